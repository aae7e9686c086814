"""Rules across rows against loops, duplicates against all pairs."""

import random

from pyspark.sql import functions as F

from foliospark.operators import quality


def rows_of(df):
    return sorted((r["rule"], r["row_id"]) for r in df.collect())


def test_planted_violations(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "b", None, "x"), (4, "b", None, "x"), (5, None, 2, None), (6, None, 2, "z"), (7, "c", 3, "w")], "i int, k string, n int, v string")
    assert rows_of(quality.not_unique(rows, "i", ["k", "n"])) == [("unique k, n", "1"), ("unique k, n", "2")]
    assert rows_of(quality.not_dependent(rows, "i", ["k"], "v")) == [("k gives v", i) for i in "1256"]
    others = spark.createDataFrame([("x",), ("x",), ("z",), (None,)], "u string")
    assert rows_of(quality.not_referring(rows, "i", "v", others, "u")) == [("v refers", "2"), ("v refers", "7")]
    assert quality.not_unique(rows.where("false"), "i", ["k"]).count() == 0


def edited(draw, text, n):
    for _ in range(n):
        i = draw.randrange(len(text))
        text = text[:i] + draw.choice(["", draw.choice("abcdef"), text[i] + draw.choice("abcdef")]) + text[i + 1 :]
    return text


def test_recall_of_duplicates(spark):
    draw, rows, truth = random.Random(3), [], set()
    for i in range(400):
        base = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30))
        rows.append((2 * i, base))
        if draw.random() < 0.5:
            rows.append((2 * i + 1, edited(draw, base, draw.choice([1, 2, 3]))))
            truth.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame([*rows, (9000, None), (9001, None)], "i int, t string")
    pairs = quality.alike_pairs(df, "i", [F.col("t"), F.reverse("t"), F.expr("substr(t, 11)")], lambda a, b: quality.likeness(a("t"), b("t")), 0.85)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    recall, false = len(found & truth) / len(truth), found - truth
    print(f"recall {recall:.3f} of {len(truth)}")
    assert recall >= 0.9 and not false


def test_chains_are_joined_up(spark):
    draw = random.Random(5)
    nodes = list(range(200))
    draw.shuffle(nodes)
    pairs = list(zip(nodes[:120], nodes[1:120], strict=False)) + [(nodes[150], nodes[151]), (nodes[151], nodes[150])]
    got = dict(map(tuple, quality.grouped(spark.createDataFrame(pairs, "a int, b int")).collect()))
    want = dict.fromkeys(nodes[:120], min(nodes[:120])) | dict.fromkeys(nodes[150:152], min(nodes[150:152]))
    assert got == want
    assert quality.grouped(spark.createDataFrame([], "a int, b int")).count() == 0


def test_likeness(spark):
    df = spark.createDataFrame([("abcd", "abcx"), ("", ""), (None, "a"), ("a", None), ("", "ab")], "a string, b string")
    assert [r[0] for r in df.select(quality.likeness(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, 0.0, 0.0, 0.0]
