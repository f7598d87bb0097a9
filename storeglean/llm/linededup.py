"""Line dedup by a log-template tree.

A line's place in the tree is fixed: its number of tokens, then its leading tokens, tokens with a digit being a field
`<*>`. In a leaf each further token is literal if it stands at its position in enough documents, and a field otherwise;
where a position has many different tokens, a second, more general template has a field too. The line with its fields
is its template. Lines of a leaf that share a stretch of tokens are also held against the most frequent token of each
position among them, so that neither the values of a field nor other lines in the leaf decide what is literal. A template
that recurs across documents is dropped from all of them but the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import discard, fresh, kept, once, stored, table

#: Leading tokens that make a leaf; least tokens of a line, or of a run of consecutive lines for shorter ones.
DEPTH, MIN_TOKENS = 3, 8
#: Documents in which a verbatim line, or a template with fields found in the leaf, recurs; literal share of the latter.
VERBATIM_DOCS, TEMPLATE_DOCS, LITERAL_SHARE = 2, 8, 0.7
#: Different tokens at a position above which the general template has a field there.
MAX_CHILDREN = 16
#: Share of a text that must be that of one earlier document for it to be a copy: all of it, to the letter.
COPY_SHARE = 1.0
FIELD, _BYTES = "<*>", b"<*>"
#: Size of the map of hashes that is sent to all tasks, as a power of two of bits: 1 MB.
SIEVE_BITS = 23
_NOBODY = -(1 << 63)
_DIGIT = re.compile(rb"[0-9]")


def _doc() -> Column:
    """The id of a document, the smallest long for none."""
    return F.coalesce(F.col("doc_id"), F.lit(_NOBODY))


def tokens(line: bytes) -> list[bytes]:
    """The tokens of a line between ASCII white space, those with a digit as fields. A line that would have too few
    literals left, such as a row of numbers, is taken as it is."""
    parts = line.split()
    if not _DIGIT.search(line):
        return parts
    masked = [_BYTES if _DIGIT.search(t) else t for t in parts]
    return masked if len(parts) - masked.count(_BYTES) >= len(parts) * LITERAL_SHARE else parts


def short_runs(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first, last, tokens): the shortest runs of lines that start or end with a line of under MIN_TOKENS tokens and have
    MIN_TOKENS or more together. Each line of a recurring passage of so many tokens is in such a run, or long enough itself,
    within the passage. Lines without a token do not count."""
    held = [(at, len(line.split(None, MIN_TOKENS - 1)), line) for at, line in enumerate(text.split(b"\n"))]
    held = [x for x in held if x[1]]
    found = set()
    for k in range(len(held)):
        if held[k][1] >= MIN_TOKENS:
            continue
        for step in (1, -1):
            n, at = held[k][1], k
            while n < MIN_TOKENS and 0 <= at + step < len(held):
                at += step
                n += held[at][1]
            if n >= MIN_TOKENS:
                found.add((min(k, at), max(k, at)))
    return [(held[a][0], held[b][0], b" ".join(x[2] for x in held[a : b + 1])) for a, b in sorted(found)]


def _candidates(text: bytes, runs: bool) -> Iterator[tuple[int, int, list[bytes], int, int]]:
    """(at, upto, tokens, leaf, line) of each line with enough tokens, and with `runs` of the runs of short lines."""
    whole = ((at, at, line) for at, line in enumerate(text.split(b"\n")))
    for at, upto, line in chain(whole, short_runs(text) if runs else ()):
        if len(line) >= 2 * MIN_TOKENS - 1:
            t = tokens(line)
            if len(t) >= MIN_TOKENS:
                leaf = xxhash.xxh64_intdigest(b" ".join(t[:DEPTH]), len(t))
                yield at, upto, t, leaf, xxhash.xxh64_intdigest(b" ".join(t))


def _lists(sizes: list[int], columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each row: the rows' parts of the columns, of so many values each."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _longs(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def _keys(runs: bool):
    @F.arrow_udf("array<struct<at:int,upto:int,leaf:bigint,line:bigint>>")
    def keys(texts: pa.Array) -> pa.Array:
        sizes, rows = [], []
        for t in texts.cast(pa.binary()):
            before = len(rows)
            rows.extend((at, upto, leaf, line) for at, upto, _, leaf, line in _candidates(t.as_py() or b"", runs))
            sizes.append(len(rows) - before)
        at, upto, leaf, line = zip(*rows, strict=True) if rows else ((),) * 4
        places = {"at": pa.array(at, pa.int32()), "upto": pa.array(upto, pa.int32())}
        return _lists(sizes, places | {"leaf": _longs(leaf), "line": _longs(line)})

    return once(keys)("text")


def _lines(docs: DataFrame, runs: bool) -> DataFrame:
    """(doc, text_hash, at, upto, leaf, line): each line with enough tokens, and its hashes; with `runs` also the runs of short
    lines at to upto, each as one line. at and upto count from 0."""
    keyed = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("text_hash"), _keys(runs).alias("held"))
    return keyed.select("doc", "text_hash", F.inline("held"))


def _sieve(keys: DataFrame, bits: int = SIEVE_BITS):
    """A column function: whether a hash may be one of `keys`, and the map that tells. A map of 2^bits bits, whatever their number: it spares the
    shuffle rows that cannot match, and the join that follows decides."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(1 << bits))
    words = keys.groupBy(F.shiftright(at, 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({keys.columns[0]}, 32) as int))")).alias("held")
    )
    found = words.toPandas()  # 2^(bits - 5) rows at most
    held = np.zeros(1 << (bits - 5), np.uint32)
    held[found["word"].to_numpy(np.int64)] = found["held"].to_numpy(np.int64).astype(np.uint32)

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
        return pa.array((held[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1)

    return may, held


def _tokens_of(wanted: np.ndarray, runs: bool):
    """The tokens of the lines whose leaves may be wanted. wanted: the map of _sieve."""
    last = 32 * len(wanted) - 1

    @F.arrow_udf("array<struct<leaf:bigint,line:bigint,t:array<string>>>")
    def tokens_of(texts: pa.Array) -> pa.Array:
        sizes, leaves, lines, held, ends = [], [], [], [], [0]
        for t in texts.cast(pa.binary()):
            before, seen = len(leaves), set()
            for _, _, parts, leaf, line in _candidates(t.as_py() or b"", runs):
                at = leaf & last
                if (int(wanted[at >> 5]) >> (at & 31)) & 1 and (leaf, line) not in seen:
                    seen.add((leaf, line))
                    leaves.append(leaf)
                    lines.append(line)
                    held.extend(parts)
                    ends.append(len(held))
            sizes.append(len(leaves) - before)
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, pa.binary()).cast(pa.string()))
        return _lists(sizes, {"leaf": _longs(leaves), "line": _longs(lines), "t": words})

    return once(tokens_of)("text")


def _kinds(docs: DataFrame, kinds: DataFrame, runs: bool) -> DataFrame:
    """(leaf, line, n_docs, t): the tokens of each kind of line. kinds: leaf, line, n_docs."""
    _, wanted = _sieve(kinds.select("leaf"))
    found = docs.select(_tokens_of(wanted, runs).alias("held")).select(F.inline("held"))
    return found.join(kinds, ["leaf", "line"]).select("leaf", "line", "n_docs", "t").dropDuplicates(["leaf", "line"])


def _clusters(found: DataFrame) -> DataFrame:
    """(leaf, line, shape): the clusters of kinds of line that are alike; a line may be in several. found: see _kinds.

    With at most n (1 - LITERAL_SHARE) fields, one of so many stretches and one more after the leading tokens has none, so
    all lines of a template share it. The lines that share a stretch are a block; its centre is the most frequent token at
    each position, and the lines that have the centre's token at LITERAL_SHARE of their positions are the cluster. A block
    of the same lines as another one is left out.
    """
    n = F.size("t")
    fields = F.floor(n * (1 - LITERAL_SHARE)).cast("int")

    def start(k: Column) -> Column:
        return F.floor(k * (n - DEPTH) / (fields + 1)).cast("int") + DEPTH + 1

    stretches = F.transform(
        F.sequence(F.lit(0), fields), lambda k: F.xxhash64("leaf", k, F.slice("t", start(k), start(k + 1) - start(k)))
    )
    parts = kept(found.select("leaf", "line", "n_docs", F.explode(stretches).alias("shape")))
    blocks = (
        parts.groupBy("leaf", "shape")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_docs").alias("docs"), F.bit_xor("line").alias("lines"))
        .where((F.col("kinds") > 1) & (F.col("docs") >= TEMPLATE_DOCS))
        .groupBy("leaf", "kinds", "docs", "lines")
        .agg(F.min("shape").alias("shape"))
        .select("shape")
    )
    inside = kept(parts.join(blocks, "shape").join(found.select("leaf", "line", "t"), ["leaf", "line"]))
    often = inside.select("shape", "n_docs", F.posexplode("t").alias("i", "token")).groupBy("shape", "i", "token").agg(F.sum("n_docs").alias("often"))
    modes = often.groupBy("shape", "i").agg(F.max(F.struct("often", "token")).getField("token").alias("token"))
    centres = modes.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).getField("token").alias("centre"))
    alike = F.filter(F.zip_with("t", "centre", lambda a, b: (a == b) & (a != FIELD)), lambda same: same)
    return inside.join(centres, "shape").where(F.size(alike) >= n * LITERAL_SHARE).select("leaf", "line", "shape")


def _templates(found: DataFrame) -> DataFrame:
    """(leaf, line, exact, wide, exact_literal, wide_literal): the two templates of each kind of line, as hashes, and
    their shares of literals. found: see _kinds."""
    each = kept(found.select("leaf", "line", "n_docs", F.posexplode("t").alias("i", "token")))
    often = each.groupBy("leaf", "i", "token").agg(F.sum("n_docs").alias("often"))
    children = often.groupBy("leaf", "i").agg(F.count(F.lit(1)).alias("children"))
    marked = (
        each.join(often, ["leaf", "i", "token"])
        .join(children, ["leaf", "i"])
        .withColumn("exact", F.when(F.col("often") >= TEMPLATE_DOCS, F.col("token")).otherwise(FIELD))
        .withColumn("wide", F.when(F.col("children") <= MAX_CHILDREN, F.col("exact")).otherwise(FIELD))
        .withColumn("wide", F.when(F.col("i") < DEPTH, F.col("token")).otherwise(F.col("wide")))
        .withColumn("exact", F.when(F.col("i") < DEPTH, F.col("token")).otherwise(F.col("exact")))
    )

    def joined(name: str) -> Column:
        return F.xxhash64(F.array_sort(F.collect_list(F.struct("i", name)))).alias(name)

    def literal(name: str) -> Column:
        return F.avg((F.col(name) != FIELD).cast("double")).alias(f"{name}_literal")

    return marked.groupBy("leaf", "line").agg(joined("exact"), joined("wide"), literal("exact"), literal("wide"))


def recurring(docs: DataFrame, copies: bool = True, runs: bool = False) -> DataFrame:
    """(doc, text_hash, gone): places of the lines to drop from a document. doc is the smallest long for rows without id.

    With `copies`, only the first document with a text loses lines; the others with the same text are copies of it.
    With `runs`, short lines are looked at too, in runs."""
    lines, lines_path = stored(_lines(docs, runs), "lines")
    held = lines.select("leaf", "line", "doc").distinct()
    kinds, kinds_path = stored(
        held.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first")), "kinds"
    )
    leaves = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_docs").alias("docs"))
    several = leaves.where((F.col("kinds") > 1) & (F.col("docs") >= TEMPLATE_DOCS)).select("leaf")
    mixed = kept(kinds.drop("first").join(several, "leaf", "left_semi"))
    texts = kept(_kinds(docs, mixed, runs))
    shapes = kept(_templates(texts))

    def shaped(name: str) -> DataFrame:
        return shapes.where(F.col(f"{name}_literal") >= LITERAL_SHARE).select("leaf", "line", F.col(name).alias("shape"))

    def general(able: DataFrame) -> DataFrame:
        """(leaf, line, first): kinds whose template recurs, and the first document with it. able: leaf, line, shape."""
        where = held.join(able, ["leaf", "line"]).select("leaf", "shape", "doc").distinct()
        sizes = where.groupBy("leaf", "shape").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first"))
        sizes = sizes.where(F.col("n_docs") >= TEMPLATE_DOCS)
        return able.join(sizes, ["leaf", "shape"]).select("leaf", "line", "first")

    verbatim = kinds.where(F.col("n_docs") >= VERBATIM_DOCS).select("leaf", "line", "first")
    drop = verbatim.unionByName(general(shaped("exact"))).unionByName(general(shaped("wide"))).unionByName(general(kept(_clusters(texts))))
    drop = kept(drop.groupBy("leaf", "line").agg(F.min("first").alias("stays")))
    may, _ = _sieve(drop.select("line"))
    goes = lines.where(may(F.col("line"))).join(drop, ["leaf", "line"]).where(F.col("doc") > F.col("stays"))
    if copies:
        same = docs.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.min(_doc()).alias("original"), F.max(_doc()).alias("last"))
        same = same.where(F.col("original") < F.col("last")).drop("last")
        goes = goes.join(same, "text_hash", "left").where(F.coalesce("original", "doc") == F.col("doc"))
    gone = goes.groupBy("doc", "text_hash").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("at", "upto")))).alias("gone")
    )
    found = kept(gone)
    for path in (lines_path, kinds_path):
        discard(docs.sparkSession, path)
    return found


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places `gone`, and how many these are; null where either is null."""

    @F.arrow_udf("struct<text:string,n:bigint>")
    def left(texts: pa.Array, places: pa.Array) -> pa.Array:
        rest, n = [], []
        for t, held in zip(texts, places, strict=True):
            if not held.is_valid or not t.is_valid:
                rest.append(None)
                n.append(None)
                continue
            drop, lines = set(held.as_py()), t.as_py().split("\n")
            rest.append("\n".join(line for at, line in enumerate(lines) if at not in drop))
            n.append(len(drop))
        known = pa.array([x is None for x in n], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(n, pa.int64())], ["text", "n"], mask=known)

    return left(text, gone)


def dedup_lines(docs: DataFrame, copy_share: float = COPY_SHARE, out: str = "n_dropped", runs: bool = False) -> DataFrame:
    """The documents with the lines of recurring templates left out, and `out`, the number of lines left out.

    A template's lines stay in the first document (smallest doc_id) that has them. A document whose whole text is that
    of an earlier one is a copy and stays as it is, for near-duplicate removal to judge; a `copy_share` over 1 leaves out
    lines in copies as well. Less than the whole text makes no copy, so a share under 1 is refused. Null and empty texts
    stay. Lines of fewer than MIN_TOKENS tokens stay, unless `runs`: then a run of consecutive
    lines, empty ones between them included, goes like one line if it has MIN_TOKENS tokens or more together. Rows that share an id, and all rows
    without id, count as one document: what recurs only among them stays. Other columns go through; a column called
    like `out` is replaced.
    """
    doc, text_hash, gone = (fresh(docs, n) for n in ("_doc", "_hash", "_gone"))
    if copy_share < 1:
        raise ValueError("copy_share: only a whole text makes a copy")
    found = recurring(docs.select("doc_id", "text"), copies=copy_share == 1, runs=runs)
    per = found.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("gone").alias(gone))
    keyed = docs.withColumns({doc: _doc(), text_hash: F.xxhash64("text")})
    joined = keyed.join(per, [doc, text_hash], "left")

    others = [c for c in docs.columns if c != out]
    done = joined.withColumn(gone, _without(F.col("text"), F.col(gone)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.col(gone)["text"])
    return done.withColumns({out: F.coalesce(F.col(gone)["n"], F.lit(0).cast("long")), "text": text}).select(*others, out)


def op2_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """All documents, copies too, without their recurring lines: doc_id, n_dropped, text."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return dedup_lines(docs, copy_share=1.1, runs=True).select("doc_id", "n_dropped", "text")


QUERIES = {"op2_line_dedup": (op2_line_dedup, None)}
