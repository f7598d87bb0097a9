import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storeglean.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def check_plan(counts, capacity):
    rows = packing.plan(counts, capacity)
    filled, taken = Counter(), Counter()
    for length, low, high, each, first, offset in rows:
        for rank in range(low, high):
            at = first + (rank - low) // each
            assert offset + ((rank - low) % each) * length == filled[at]
            filled[at] += length
            taken[length] += 1
    assert taken == Counter(counts)
    assert max(filled.values(), default=0) <= capacity
    assert sorted(filled) == list(range(len(filled)))
    return len(filled)


def best_fit(counts, capacity):
    """Documents one by one, longest first, each into the fullest sequence that takes it."""
    free = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        able = [f for f in free if f >= length]
        if able:
            free.remove(min(able))
        free.append((min(able) if able else capacity) - length)
    return len(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100])
    counts = Counter(min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.choice([3, 400])))
    assert check_plan(counts, capacity) == best_fit(counts, capacity)
    assert packing.plan({}) == []


def test_ids_are_those_of_the_tokenizers_library():
    rng = random.Random(1)
    kinds = [(32, 127), (1, 0x3000), (0x3000, 0xD7FF), (0x1F000, 0x1FFFF), (32, 33), (10, 11)]
    texts = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(60)) for _ in range(800)]
    texts += ["", " ", "a  b", "\n", "don't I'M he'll", "x\ty", "<|endoftext|> z", "²½ Ⅷ", "a" * 50_000, " " * 5000 + "x", "🙂🙂 🙂"]
    added = "<|endoftext|>"
    texts += [f"hello {added} x", added, added * 3, f"a{added}b", f"{added}\n", f" {added[:-1]} {added} {added[1:]}", f"<|{added}|>"]
    texts += ["".join(rng.choice([added, "<|", "end", "|>", " ", "of", "x"]) for _ in range(30)) for _ in range(200)]
    theirs = Tokenizer.from_file(PATH)
    for text in texts:
        assert list(packing.ids(packing.encoder(PATH), text)) == theirs.encode(text, add_special_tokens=False).ids


def test_files_with_other_settings_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        asked = json.load(file)
    token = asked["added_tokens"][0]
    for change in (
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": asked["pre_tokenizer"] | {"add_prefix_space": True}},
        {"pre_tokenizer": None},
        {"added_tokens": [token | {"lstrip": True}]},
        {"model": asked["model"] | {"dropout": 0.1}},
        {"model": asked["model"] | {"vocab": asked["model"]["vocab"] | {"!": 1, '"': 0}, "merges": asked["model"]["merges"][::-1]}},
    ):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(asked | change))
        packing.encoder.cache_clear()
        with pytest.raises(ValueError, match="not built|do not follow"):
            packing.encoder(str(path))
    packing.encoder.cache_clear()


def test_pieces_and_places(docs, prose):
    rows = [(i, prose(i, 1 + 37 * i % 400)) for i in range(60)] + [(1, "a"), (1, "a"), (None, "b"), (7, None), (8, ""), (9, prose(3, 5000))]
    table = docs(rows).withColumn("length", F.lit("x")).withColumn("piece", F.lit("y"))
    got = packing.pack(table, PATH, 256).collect()
    theirs = Tokenizer.from_file(PATH)
    wanted = Counter()
    for i, text in rows:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range(len(ids) % 256 or 256, len(ids), 256)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            wanted[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256
    assert len(filled) == best_fit(Counter(r["length"] for r in got), 256)
    assert packing.pack(docs([]), PATH).collect() == []
