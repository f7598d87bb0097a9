import gzip
import hashlib
import json

import pytest

from storeglean.llm import warc

PAGES = "page_id long, url string, html string, digest string, kind int"


@pytest.fixture()
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "d", 7) for r in rows], PAGES)

    return make


BIG, OTHER = "é<p>" * 50, "x" * 100
ROWS = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (7, "bad\r\nWARC-Type: x y", OTHER), (-4, "u", "y" * 99), (8, "u", "y" * 99),
    (1, "u", ""), (2, "u", None), (None, "n", BIG), (None, "n", "z" * 300), (None, "n", "z" * 300), (3, "http://a/3", BIG), (40, "u", "a\r\n\r\nb" * 40_000),
]


def wanted(rows):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = first.get(raw)
        to = None if to == i else to
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(32 << 20, 8 << 20), (300, 500)])
def test_round_trip(spark, pages, tmp_path, sizes):
    path = f"{tmp_path}/one"
    warc.write(pages(ROWS), path, *sizes)
    got = warc.read(spark, path).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == wanted(ROWS)
    bodies = {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"}
    assert (3, BIG.encode()) in bodies and (40, ("a\r\n\r\nb" * 40_000).encode()) in bodies and (2, b"") in bodies
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    assert {r["url"] for r in got if r["page_id"] == 7} == {"bad%0D%0AWARC-Type:%20x%20y"}
    # the same bytes again, whatever the partitions, and nothing but what the manifest lists
    again = f"{tmp_path}/two"
    warc.write(pages(ROWS[::-1]).repartition(5), again, *sizes)
    files = {r["name"]: r["sha256"] for r in warc.manifest(spark, path).collect()}
    assert files == {r["name"]: r["sha256"] for r in warc.manifest(spark, again).collect()}
    there = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "one").glob("*.warc.gz")}
    assert there == files
    text = b"".join(gzip.decompress((tmp_path / "one" / n).read_bytes()) for n in sorted(files))
    assert text.count(b"WARC/1.1\r\n") == len(ROWS) + len(files)


def test_leftovers_are_not_read_and_damage_is_found(spark, pages, tmp_path):
    path = f"{tmp_path}/a"
    warc.write(pages(ROWS), path)
    (tmp_path / "a" / "shard-000099-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, path, payloads=False).count() == len(ROWS)
    (name,) = [r["name"] for r in warc.manifest(spark, path).collect()]
    raw = bytearray((tmp_path / "a" / name).read_bytes())
    raw[len(raw) // 2] ^= 255
    (tmp_path / "a" / name).write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        warc.read(spark, path).collect()


def test_renaming_can_be_repeated(spark, pages, tmp_path):
    path = f"{tmp_path}/a"
    warc.write(pages(ROWS), path)
    drafts = [json.loads(x) for p in (tmp_path / "a" / "_drafts").glob("part-*") for x in p.read_text().splitlines()]
    table = spark.createDataFrame([tuple(d[c.split(" ")[0]] for c in warc.FILES.split(", ")) for d in drafts], warc.FILES)
    assert table.mapInArrow(warc._publish(path), warc.FILES).count() == len(drafts)


def test_empty_table(spark, pages, tmp_path):
    warc.write(pages([]), f"{tmp_path}/a")
    assert warc.read(spark, f"{tmp_path}/a").collect() == []


def test_shards_are_cut_wherever_ids_lie(spark, pages, tmp_path, monkeypatch):
    """Ids in one place, one far out, a third of the rows without id: shards are of one size, and nothing depends on the tasks."""
    monkeypatch.setattr(warc, "ROWS_AT_ONCE", 50)
    rows = [(10**15 + i, "u", f"{i}" * 40) for i in range(300)] + [(None, "n", f"n{i}" * 40) for i in range(200)]
    rows += [(9 * 10**18, "u", "far"), (-5, "u", "low")] + [(7, "u", f"same id {i}" * 20) for i in range(200)]
    files = []
    for k, table in enumerate((pages(rows), pages(rows[::-1]).repartition(7))):
        warc.write(table, f"{tmp_path}/{k}", 20_000, 1 << 20)
        files.append({r["name"]: (r["sha256"], r["n_records"]) for r in warc.manifest(spark, f"{tmp_path}/{k}").collect()})
    assert files[0] == files[1]
    sizes = [n for _, n in files[0].values()]
    assert len(sizes) > 15 and max(sizes) <= 20_000 // warc.HEAD_BYTES + 2
    ids = [r["page_id"] for r in sorted(warc.read(spark, f"{tmp_path}/0").collect(), key=lambda r: (r["page_id"] is not None, r["page_id"] or 0))]
    assert ids.count(None) == 200 and ids.count(7) == 200 and len(ids) == len(rows)
