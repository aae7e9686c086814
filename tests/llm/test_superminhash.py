"""SuperMinHash groups against all pairs of word sets, and what is left in the shared folder."""

import os
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import common, jaccard, superminhash


def word_set(text):
    w = (text or "").split()
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    sets = [word_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g, s in zip(rows, group, sets, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted([(i, len(s), least.get(g), i is not None and least.get(g) == i) for (i, _), g, s in zip(rows, group, sets, strict=True)], key=str)


def found(spark, rows, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "size": F.lit("x"), "root": F.lit(0), "kept": F.lit(7)})
    return sorted([tuple(r) for r in superminhash.near_groups(docs.repartition(3), percent=percent).collect()], key=str)


def family(draw, n, words=150, changes=4, tag="w"):
    base = [f"{tag}{draw.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for at in draw.sample(range(0, words, 7), changes):
            own[at] = f"x{draw.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def planted():
    draw, texts = random.Random(6), []
    for _ in range(12):
        texts += family(draw, 4, changes=draw.choice([1, 2, 3]))
    texts += family(draw, 40, changes=2)  # copies close to the first, many not to one another
    texts += [texts[3]] * 5 + ["One two", "one TWO", "a b c d e", "a b c d e f", None, "", " \n", "É b", "é b", "long " + "tail " * 3000]
    exact = [f"e{i}" for i in range(41)]  # 37 shingles each, 34 in common: 34 of 40 is 85 percent
    texts += [" ".join(exact), " ".join(exact[3:] + ["y1", "y2", "y3"]), " ".join(exact[4:] + ["z1", "z2", "z3", "z4"])]
    draw.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[0]), (None, "only here"), (None, None), (5, texts[5])]


def test_groups_equal_all_pairs(spark):
    rows = planted()
    assert found(spark, rows) == brute(rows, 85)


def test_what_rounds_leave_open(spark, monkeypatch):
    """Without rounds every bucket is settled by the rare shingles of its nodes."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    rows = planted()
    assert found(spark, rows) == brute(rows, 85)
    monkeypatch.setattr(jaccard, "SAMPLE", 500)
    monkeypatch.setattr(jaccard, "COMMON", 20)  # the order is no matter to what is found
    monkeypatch.setattr(jaccard, "SENT", 3)
    assert found(spark, rows) == brute(rows, 85)


def test_near_texts_that_are_not_alike_meet_seldom(spark):
    """Three hundred copies at a similarity of some 0.7 to one another: few of their 44,850 pairs are compared."""
    texts = family(random.Random(4), 300, words=200, changes=4)[1:]
    sets = [superminhash.shingles_of(t.encode(), 5) for t in texts]
    assert len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1])) > 0.6
    nodes = spark.createDataFrame([(i, i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "key long, root long, hashes binary")
    pairs = jaccard.prefix_pairs(jaccard.prefixes(nodes, jaccard.common_shingles(nodes), 85), 85)
    assert pairs.count() < 500


def test_every_row_comes_back_from_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None), (4, "")]) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_near_dedup_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (3, None, "z")], "doc_id long, text string, n string")
    out = superminhash.near_dedup(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "a b c d e f g", "y"), (3, None, "z")]


def test_signature_is_the_definition():
    rng, mask = np.random.default_rng(1), 2**64 - 1
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 9, 200)]
    for own, got in zip(sets, superminhash.signatures(sets), strict=True):
        want = [mask] * superminhash.PLACES
        for e in own.tolist():
            order = list(range(superminhash.PLACES))
            for rank in range(superminhash.PLACES):
                draw = superminhash.mixed(np.array([(e + (2 * rank + 1) * int(superminhash._A)) & mask], np.uint64))
                j = rank + (int(draw[0]) >> 32) % (superminhash.PLACES - rank)
                order[rank], order[j] = order[j], order[rank]
                offer = rank << 56 | int(superminhash.mixed(draw ^ superminhash._C)[0]) >> 8
                want[order[rank]] = min(want[order[rank]], offer)
        assert got.tolist() == want
    alone = np.unique(rng.integers(0, 2**64, superminhash.TOGETHER * 2 + 9, dtype=np.uint64))
    assert (superminhash.signatures([alone])[0] >> np.uint64(56) == 0).all()


def test_less_variance_than_independent_minima():
    rng, estimates = np.random.default_rng(3), []
    for _ in range(200):
        common_, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (85, 8, 7))
        x, y = superminhash.signatures([np.r_[common_, a], np.r_[common_, b]])
        estimates.append((x == y).mean())
    assert abs(np.mean(estimates) - 0.85) < 0.01 and np.std(estimates) < 0.9 * (0.85 * 0.15 / superminhash.PLACES) ** 0.5


def tables(spark):
    return {x for x in os.listdir(common.shared_folder(spark).removeprefix("file://") + "/foliospark") if not x.startswith("stream-")}


def test_no_table_stays_but_those_that_the_result_reads(spark):
    rows = planted()[:80]
    found(spark, rows[:5])  # the folder is there
    for group, left in ((superminhash.near_groups, 1), (jaccard.near_groups, 1)):
        before = tables(spark)
        out = group(spark.createDataFrame(rows, "doc_id long, text string"))
        assert len(tables(spark) - before) == left, tables(spark) - before
        assert out.count() == len(rows)
