"""SimHash groups and source mixing against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from foliospark.llm import mixing, simhash

DOCS = "doc_id long, text string, source string, fingerprint string, component_id int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(prints, radius=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 40, 200, 400])))
        rows.append((i * 10, text))
        if i % 3 == 0:  # near copies
            for k in range(1, 4):
                part = text.split(" ")
                part[rng.randrange(len(part))] = rng.choice(words)
                rows.append((i * 10 + k, " ".join(part)))
    return [*rows, (5000, None), (5001, ""), (5002, " \t\n"), (5003, "É É É É é"), (5004, rows[0][1].upper()), (7, rows[0][1]), (7, rows[0][1])]


def test_fingerprints_and_groups(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], DOCS)
    got = sorted((r[0], r[1] % 2**64, r[2]) for r in simhash.near_groups(df).collect())
    prints = [brute_print(t) for _, t in rows]
    root, least = brute_groups(prints), defaultdict(lambda: 10**9)
    for (i, _), g in zip(rows, root, strict=True):
        least[g] = min(least[g], i)
    assert got == sorted((i, p, least[g]) for (i, _), p, g in zip(rows, prints, root, strict=True))


def test_large_buckets_are_compared_in_blocks(spark):
    """More nodes in one bucket than a block holds: a ball of fingerprints around one value, and lone ones."""
    rng = np.random.default_rng(5)
    prints = {0}
    while len(prints) < 1800:
        prints.add(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    prints |= {int(x) for x in rng.integers(0, 2**63, 300)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)], "id long, print long").repartition(3)
    from foliospark.llm.components import connected_components

    found = dict(connected_components(simhash.near_links(nodes)).collect())
    want = brute_groups(prints)
    assert [found.get(i, i) for i in range(len(prints))] == want


def test_masks_cover_every_pair():
    rng, masks = np.random.default_rng(1), simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(differ & m % 2**64 == 0 for m in masks)


def test_dedup_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in [*rows, (None, "only here once and nowhere else"), (None, rows[0][1])]], DOCS)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    groups = {r[0]: r[2] for r in simhash.near_groups(df).collect() if r[0] is not None}
    ids = sorted(r[0] for r in kept.collect() if r[0] is not None)
    assert ids == sorted(set(groups.values()))
    assert [r[1] for r in kept.collect() if r[0] is None] == ["only here once and nowhere else"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_groups(df).count() == 0
    assert simhash.near_dedup(df).count() == 0
    assert mixing.mix(df).count() == 0
    assert mixing.mixed_documents(df).count() == 0


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    target, held = {}, set()
    budget = share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        if not free:
            break
        rest = budget - sum(cap * sizes[s] for s in held)
        level = rest / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level >= cap * sizes[s]]
        if not over:
            target = {s: weights[s] * level for s in free}
            break
        held |= set(over)
    return target | {s: cap * sizes[s] for s in held}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", "c", "d", "Z", None]), "x", 1) for i in range(400)]
    rows += [(None, None, "a", "x", 1), (3, "", "e", "x", 1), (3, "one two", "b", "x", 1), (3, "one two", "b", "x", 1)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows_are_whole(spark):
    rows = [(i, " ".join("w" * (1 + i % 7)), "ab"[i % 2], "x", 1) for i in range(60)] + [(1, "w w", "b", "x", 1)] * 3
    out = mixing.mixed_documents(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "source", "fingerprint", "component_id"]
    words = defaultdict(int)
    for r in out.collect():
        assert (r["doc_id"], r["text"], r["source"], "x", 1) in rows
        words[r["source"]] += len(r["text"].split())
    plan = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(abs(words[s] - plan[s]) <= 7 for s in plan)
