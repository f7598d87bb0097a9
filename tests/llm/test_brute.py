"""Operators without a SQL statement against plain versions of their rules, written independently."""

import math
import random
import struct

import numpy as np
import xxhash

from pyspark.sql import functions as F

from storeglean.llm import hashed, langid, ordinal, sharding, toxicity


def chosen_shard(key, weights):
    """The shard of the largest weight / -ln(u), by trying all; hashes as XXH64 with seed 42, column after column."""
    best = None
    for shard, weight in enumerate(weights):
        seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 32
        score = weight / -math.log((h + 0.5) / (1 << 32)) if weight else -1.0
        if best is None or score > best[0]:
            best = (score, shard)
    return best[1]


def test_shards_by_trying_all(docs):
    ids = [*range(-50, 300), 10**15, None]
    for weights in ([1.0] * 16, [1.0] * 17, [0.5, 0.0, 3.0, 1.0]):
        got = sharding.assign(docs([(i, "t") for i in ids]), ["doc_id"], weights).collect()
        assert {r["doc_id"]: r["shard"] for r in got} == {i: chosen_shard(i, weights) for i in ids}
    laid = sharding.layout(docs([(i, "t") for i in ids])).collect()
    assert all(r["shard"] == chosen_shard(r["doc_id"], [1.0] * 16) and r["grown_shard"] == chosen_shard(r["doc_id"], [1.0] * 17) for r in laid)


def mixture(counts, models, rounds=400):
    """Proportions of models (dicts of probabilities) that make counts (a dict) likeliest, and the log-likelihood."""
    shares = {k: 1 / len(models) for k in models}
    total = sum(counts.values())
    for _ in range(rounds):
        new = dict.fromkeys(models, 0.0)
        for slot, n in counts.items():
            whole = sum(shares[k] * models[k][slot] for k in models)
            for k in models:
                new[k] += n * shares[k] * models[k][slot] / whole
        shares = {k: v / total for k, v in new.items()}
    return shares, sum(n * math.log(sum(shares[k] * models[k][s] for k in models)) for s, n in counts.items())


def likeliest(counts, models):
    """The set of languages by backward selection on the penalised likelihood, and its proportions."""
    scaled = {s: n * langid.INDEPENDENCE for s, n in counts.items()}
    penalty = 0.5 * math.log(max(sum(scaled.values()), 2))
    held = dict(models)
    shares, likely = mixture(scaled, held)
    while len(held) > 1:
        least = min(held, key=lambda k: (shares[k], list(models).index(k)))
        fewer = {k: v for k, v in held.items() if k != least}
        new, value = mixture(scaled, fewer)
        if value + penalty < likely:
            break
        held, shares, likely = fewer, new, value
    return shares


def test_language_mixtures_by_dicts():
    rng = random.Random(3)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for k, letters in (("a", "abcdeo"), ("b", "efghio"), ("c", "klmnuo"))}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    table = np.full((3, langid.SLOTS), langid.SMOOTHING)
    for i, k in enumerate(vocab):
        slots, counts = langid.trigrams(text(k, 3000))
        table[i, slots] += counts
    p = table / table.sum(1, keepdims=True)
    for parts in ([("a", 40)], [("a", 60), ("b", 30)], [("a", 30), ("b", 30), ("c", 30)], [("c", 2)], [("b", 50), ("c", 3)]):
        slots, counts = langid.trigrams(" ".join(text(k, n) for k, n in parts))
        plain = likeliest(dict(zip(slots.tolist(), counts.tolist(), strict=True)), {k: p[i] for i, k in enumerate(vocab)})
        held, shares = langid.infer(slots, counts, np.log(p))
        found = {list(vocab)[i]: s for i, s in zip(held, shares, strict=True)}
        assert found.keys() == plain.keys()
        assert all(abs(found[k] - plain[k]) < 0.01 for k in found)


def slope(objective, weights, bias, names):
    """The derivative of an objective by each of some weights and the last argument, by differences."""
    step, out = 1e-5, []
    for name in names:
        values = []
        for sign in (1, -1):
            moved = dict(weights)
            moved[name] += sign * step
            values.append(objective(moved, bias))
        out.append((values[0] - values[1]) / (2 * step))
    out.append((objective(weights, bias + step) - objective(weights, bias - step)) / (2 * step))
    return np.array(out)


def test_toxicity_weights_are_at_the_least_of_the_plain_objective(spark):
    rng, rows = random.Random(5), []
    for i in range(240):
        words = [rng.choice(["kalo", "mero", "pilu", "zado", "fenu"]) for _ in range(6)]
        if i % 2:
            words[0] = "vilegrub"
        if rng.random() < (0.7 if i % 2 else 0.2):
            words[1] = rng.choice(["women", "gay"])
        rows.append((" ".join(words) + ".", float((i % 2) ^ (rng.random() < 0.1)), 1.0 + i % 3))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label double, weight double"))
    places = {t: set(hashed.slots(t).tolist()) for t, _, _ in rows}
    pairs = [(t, toxicity.swapped(t, by)) for t, _, _ in rows if "women" in t or "gay" in t for by in range(1, toxicity.SWAPS + 1)]
    total = sum(w for *_, w in rows)

    def logit(text, weights, bias):
        own = places[text] if text in places else places.setdefault(text, set(hashed.slots(text).tolist()))
        return bias + sum(weights.get(p, 0.0) for p in own)

    def objective(weights, bias):
        loss = sum(w / total * math.log1p(math.exp(-s * (1 if y else -1))) for t, y, w in rows for s in [logit(t, weights, bias)])
        change = sum((logit(a, weights, 0) - logit(b, weights, 0)) ** 2 for a, b in pairs) / len(pairs)
        return loss + toxicity.PENALTY * change + toxicity.RIDGE * sum(v * v for v in weights.values())

    names = sorted(model.weights, key=lambda k: -abs(model.weights[k]))[:6] + sorted(model.weights)[:3]
    assert model.weights and np.abs(slope(objective, model.weights, model.bias, names)).max() < 2e-3
    start = dict.fromkeys(model.weights, 0.0)
    assert objective(model.weights, model.bias) < 0.8 * objective(start, 0.0)
    df = spark.createDataFrame([(t,) for t, *_ in rows[:20]], "text string")
    for r in df.select("text", toxicity.probability(F.col("text"), model).alias("p")).collect():
        assert math.isclose(r["p"], 1 / (1 + math.exp(-logit(r["text"], model.weights, model.bias))), rel_tol=1e-9)


def test_ordinal_weights_are_at_the_least_of_the_plain_objective(spark):
    rng, rows = random.Random(6), []
    for i in range(240):
        words = [rng.choice(["kalo", "mero", "pilu", "zado", "fenu"]) for _ in range(6)] + ["splendid", "careful"][: i % 3]
        if rng.random() < 0.2:
            words.append("splendid")
        rows.append((" ".join(words), float(i % 3), 1.0 + i % 2))
    model = ordinal.fit(spark.createDataFrame(rows, "text string, label double, weight double"))
    places = {t: set(ordinal.of_text(t).tolist()) for t, *_ in rows}
    total = sum(w for *_, w in rows)

    def tail(text, k, weights, thresholds):
        return 1 / (1 + math.exp(thresholds[k] - sum(weights.get(p, 0.0) for p in places[text])))

    def objective(weights, shift, gap=0.0):
        cuts, loss = [model.thresholds[0] + shift, model.thresholds[1] + shift + gap], 0.0
        for t, y, w in rows:
            edges = [1.0, tail(t, 0, weights, cuts), tail(t, 1, weights, cuts), 0.0]
            loss -= w / total * math.log(edges[int(y)] - edges[int(y) + 1])
        return loss + ordinal.RIDGE * sum(v * v for v in weights.values())

    names = sorted(model.weights, key=lambda k: -abs(model.weights[k]))[:6]
    assert np.abs(slope(objective, model.weights, 0.0, names)).max() < 2e-3
    assert abs(objective(model.weights, 0.0, 1e-4) - objective(model.weights, 0.0, -1e-4)) / 2e-4 < 2e-3
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows[:20])], "doc_id long, text string")
    for r in ordinal.rate(df, model).collect():
        wanted = [tail(rows[r["doc_id"]][0], k, model.weights, model.thresholds) for k in (0, 1)]
        assert np.allclose(r["tails"], wanted) and math.isclose(r["expected_grade"], sum(wanted), rel_tol=1e-9)
