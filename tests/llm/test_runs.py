"""Periodic runs against a definition read word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import runs


def brute(words, least=6, times=4):
    """Every run by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(length >= 2 * p and all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if j > i and length >= max(least, times * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_those_of_all_periods():
    draw = random.Random(3)
    for _ in range(1500):
        n, letters = draw.choice([0, 1, 5, 6, 7, 20, 60, 90]), draw.choice([1, 2, 3, 6])
        words = [draw.randrange(letters) for _ in range(n)]
        if n > 8 and draw.random() < 0.6:
            start, period = draw.randrange(n), draw.randrange(1, 6)
            words = words[:start] + [words[start + i % period] if start + i % period < n else 0 for i in range(n - start)]
        assert runs.runs_of(np.array(words, np.int64)) == brute(words), words


def test_one_word_repeated_throughout_a_very_long_text():
    assert runs.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.runs_of(np.tile(np.arange(3), 50_000)) == [(0, 150_000, 3)]


def test_ordered_positions():
    draw, held = random.Random(5), [500_000]
    found = runs.Positions(500_000)
    for x in draw.sample(range(400_000), 5000):
        below, above = found.around(x)
        assert below == max((y for y in held if y < x), default=None) if len(held) < 200 else True
        assert above == min((y for y in held if y > x), default=None) if len(held) < 200 else True
        found.add(x)
        held.append(x)
    assert list(found) == sorted(held) and found.size == len(held)


def test_query_on_odd_documents(spark, tmp_path):
    draw = random.Random(9)
    texts = [None, "", " \t\n", "a", "a " * 6, "a b " * 4, "x" + " y z" * 30 + " w", "é ü " * 9, " ".join("ab"[i % 7 > 3] for i in range(300))]
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(120))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "words": F.lit("x"), "runs": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(expected(*r) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    assert runs.document_runs(none).count() == 0


def test_null_id(spark):
    docs = spark.createDataFrame([(None, "a " * 9), (None, "a " * 9)], "doc_id long, text string")
    assert [r["collapsed"] for r in runs.document_runs(runs.with_planted_runs(docs)).collect()] == ["a", "a"]
