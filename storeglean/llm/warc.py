"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of the page id, sorted, and written as gzip members; a file is closed once its
compressed size reaches a limit. Headers, ids and digests follow from the rows, so the same rows give the same bytes.
Tasks write under temporary names that no other attempt uses and report them in a manifest; when all are done, files are
renamed and the final manifest is written. A reader opens only files of the manifest, so what lost or repeated tasks
leave behind is never seen.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import kept, scratch, table

#: Payload of a shard, compressed size of a file, and the least payload whose copies become revisits, in bytes.
SHARD_BYTES, FILE_BYTES, REVISIT_BYTES = 32 << 20, 8 << 20, 100
#: Rows of a task that cuts shards, and bytes that a record counts besides its payload.
ROWS_AT_ONCE, HEAD_BYTES = 500_000, 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "name string, temporary string, n_bytes long, n_records long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(page_id: int | None, digest: str) -> str:
    """The same URN for the same page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member without a time."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _page(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: a response, or a revisit without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)),
        ("Page-Id", page_id),
        ("Payload-Length", len(payload)),
        ("Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, block)


def _write_shard(path: str, file_bytes: int):
    """The task that writes a shard: rows in order of page_id and digest, a row of kind 0 with the page that the next
    rows of the same page and digest refer to before those of kind 1 with the payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(path)
        attempt, refers, file = uuid.uuid4().hex, (None, None, None), None
        closed: list[tuple] = []
        name = ""

        def close() -> None:
            nonlocal file
            if file is not None:
                file[0].close()
                closed.append((name, f"{name}.{attempt}", file[1], file[2], file[3].hexdigest()))
                file = None

        def add(data: bytes) -> None:
            file[0].write(data)
            file[1] += len(data)
            file[2] += 1
            file[3].update(data)

        for batch in batches:
            for row in zip(*[batch[c] for c in ("shard", "page_id", "digest", "kind", "refers_to", "url", "payload")], strict=True):
                shard, page, digest, kind, refers_to, url, payload = (v.as_py() for v in row)
                if kind == 0:
                    refers = (page, digest, refers_to)
                    continue
                if file is None:
                    name = f"shard-{shard:06d}-{len(closed):05d}.warc.gz"
                    file = [system.open_output_stream(f"{base}/_temporary/{name}.{attempt}", compression=None), 0, 0, hashlib.sha256()]
                    add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                add(_page(page, url, digest, payload, refers[2] if refers[:2] == (page, digest) else None))
                if file[1] >= file_bytes:
                    close()
        close()
        columns = list(zip(*closed, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["name", "temporary", "n_bytes", "n_records", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return write


def _publish(path: str):
    """The task that renames files; a file that an earlier attempt renamed is left."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(path)
        for batch in batches:
            for name, temporary, size in zip(batch["name"], batch["temporary"], batch["n_bytes"], strict=True):
                final = f"{base}/{name.as_py()}"
                held = system.get_file_info(final)
                if held.type == fs.FileType.NotFound:
                    system.move(f"{base}/_temporary/{temporary.as_py()}", final)
                elif held.size != size.as_py():
                    raise OSError(f"{final} has {held.size} bytes")
            yield batch

    return rename


def _key(page_id: int | None, digest: str) -> tuple[bool, int, str]:
    """The place of a row in the order of an archive; rows without id come first."""
    return (page_id is not None, page_id or 0, digest)


def _borders(narrow: DataFrame, shard_bytes: int) -> list[tuple[bool, int, str]]:
    """The places at which a new shard begins: all rows in the order of page id and digest, cut after every `shard_bytes`.

    Rows are sorted by ranges, wherever these lie; a row's shard follows from the bytes before it in the whole order, so the
    same rows give the same borders, and ids that lie close, far out or are missing are cut like others. A row for each range
    and shard comes to the driver.
    """
    sized = narrow.select("page_id", "digest", (F.col("n_bytes") + HEAD_BYTES).alias("n"))
    parts = max(1, -(-narrow.count() // ROWS_AT_ONCE))
    order = kept(sized.repartitionByRange(parts, "page_id", "digest").sortWithinPartitions("page_id", "digest"))
    sums = dict(order.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n").alias("n")).collect())
    ahead, total = {}, 0
    for part in sorted(sums):
        ahead[part], total = total, total + sums[part]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = ahead.get(TaskContext.get().partitionId(), 0), None
        for batch in batches:
            sizes = batch["n"].to_numpy()
            shard = (at + np.cumsum(sizes) - sizes) // shard_bytes
            at += int(sizes.sum())
            new = np.flatnonzero(np.diff(shard, prepend=-1 if last is None else last))
            last = shard[-1] if len(shard) else last
            yield pa.RecordBatch.from_arrays([pa.array(shard[new]), batch["page_id"].take(new), batch["digest"].take(new)], ["shard", "page_id", "digest"])

    first: dict[int, tuple] = {}
    for found in order.select(F.col("page_id").cast("long").alias("page_id"), "digest", "n").mapInArrow(firsts, "shard long, page_id long, digest string").collect():
        key = _key(found["page_id"], found["digest"])
        first[found["shard"]] = min(first.get(found["shard"], key), key)
    return [first[s] for s in sorted(first)][1:]


def _shard_of(borders: list[tuple[bool, int, str]]):
    @F.arrow_udf("int")
    def shard(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        rows = zip(page_id.to_pylist(), digest.to_pylist(), strict=True)
        return pa.array([bisect_right(borders, _key(*row)) for row in rows], pa.int32())

    return shard("page_id", "digest")


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) into a new folder and returns the manifest.

    The payload is the html in UTF-8; null is empty. Of equal payloads of REVISIT_BYTES or more that with the smallest
    page_id is the response and the others revisit it; rows that share the id and the payload are all responses, and so
    are rows without id whose payload no page with an id has. Rows without id come first. An empty table gives an empty
    manifest. Other columns are not read. A shard holds `shard_bytes` or so, more only where rows of one id and payload do. The
    path must be one that all executors share.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digest = F.sha2(payload, 256)
    narrow = kept(pages.select("page_id", digest.alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes")))
    able = narrow.where(F.col("n_bytes") >= REVISIT_BYTES)
    first = able.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = able.join(first, "digest").where("page_id is null or page_id <> refers_to").where("refers_to is not null")
    borders = _borders(narrow, shard_bytes)
    shards = len(borders) + 1

    nothing = {"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}
    columns = ["page_id", "digest", "kind", "refers_to", "url", "payload"]
    marks = again.select("page_id", "digest", "refers_to").distinct()
    marks = marks.withColumns({"kind": F.lit(0), **nothing}).select(columns)
    full = pages.select(
        "page_id", digest.alias("digest"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("refers_to"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
    )
    dealt = marks.unionByName(full).withColumn("shard", _shard_of(borders))
    tasks = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("page_id", "digest", "kind", "url")
    system, base = _open(path)
    system.create_dir(f"{base}/_temporary", recursive=True)
    drafts = f"{path}/_drafts"
    tasks.mapInArrow(_write_shard(path, file_bytes), FILES).write.json(drafts)
    files = spark.read.schema(FILES).json(drafts)
    files.repartition(shards, "name").mapInArrow(_publish(path), FILES).drop("temporary").write.json(f"{path}/_manifest")
    system.delete_dir(f"{base}/_temporary")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a finished archive."""
    return spark.read.schema("name string, n_bytes long, n_records long, sha256 string").json(f"{path}/_manifest")


def _members(file, digest) -> Iterator[bytes]:
    """The records of a file, one at a time."""
    unpacker, held = zlib.decompressobj(31), []
    rest = b""
    while True:
        data = rest or file.read(1 << 20)
        if not rest:
            digest.update(data)
        if not data:
            break
        held.append(unpacker.decompress(data))
        rest = b""
        if unpacker.eof:
            rest = unpacker.unused_data
            yield b"".join(held)
            unpacker, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("a record is cut off")


def parse(raw: bytes) -> dict | None:
    """A record of a page, its digests checked; None for a record of another kind."""
    head, _, body = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = body[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a record")
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{headers['WARC-Record-ID']}: the block is damaged")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(headers["Payload-Length"])):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is damaged")
    whole = {k: int(headers[h]) if h in headers else None for k, h in (("page_id", "Page-Id"), ("refers_to", "Refers-To-Page-Id"))}
    return whole | {
        "url": headers.get("WARC-Target-URI"),
        "payload_bytes": int(headers["Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "payload": payload,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The pages of an archive: RECORDS. Files are streamed, one a task at a time; digests of files, blocks and payloads
    are checked, and damage is an error. `payload` is null for revisits, and for all if `payloads` is false."""
    kind = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(path)
        for batch in batches:
            for name, wanted in zip(batch["name"], batch["sha256"], strict=True):
                whole, rows, size = hashlib.sha256(), [], 0
                with system.open_input_stream(f"{base}/{name.as_py()}", compression=None) as file:
                    for raw in _members(file, whole):
                        if row := parse(raw):
                            rows.append(row if payloads else row | {"payload": None})
                            size += len(raw)
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                if whole.hexdigest() != wanted.as_py():
                    raise ValueError(f"{name} is not the file of the manifest")
                yield pa.RecordBatch.from_pylist(rows, kind)

    files = manifest(spark, path).select("name", "sha256")
    tasks = max(1, min(files.count(), 20 * spark.sparkContext.defaultParallelism))
    return files.repartition(tasks, "name").mapInArrow(records, RECORDS)


def op5_warc(spark: SparkSession, directory: str) -> DataFrame:
    """All pages, written as an archive into the shared folder and read back."""
    path = scratch(spark, "warc")
    write(table(spark, directory, "pages"), path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
),
firsts AS (SELECT digest, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM p LEFT JOIN firsts USING (digest)
"""

QUERIES = {"op5_warc": (op5_warc, SQL)}
