"""Ranked lexical search against scores counted term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in c}
            score = sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in w)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, k):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "score": F.lit(2)})
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("y"))
    return sorted(tuple(r) for r in lexical.search(lexical.build_index(docs).repartition(3), items, k).collect())


def test_equal_to_brute_force(spark, monkeypatch):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "ÄB", "Zz9", "日本"]
    def text():
        return draw.choice([" ", "-", "\n"]).join(draw.choice(words[: draw.choice([5, 65])]) for _ in range(draw.choice([1, 8, 40, 400])))
    docs = [(i, text()) for i in range(300)]
    docs += [(i + 300, docs[i % 5][1]) for i in range(60)]  # copies: ties
    docs += [(900, None), (901, ""), (902, " -\t"), (None, "w1 w2"), (903, "w3 " * 700), (904, "w1"), (904, "w1")]
    items = [(i, text()) for i in range(20)] + [(50, None), (51, ""), (52, "unknown"), (None, "w1"), (53, "w1 W1 w1"), (53, "w2")]
    want = brute(docs, items, 10)
    assert found(spark, docs, items, 10) == want
    monkeypatch.setattr(lexical, "BATCH_TERMS", 40)  # several batches
    monkeypatch.setattr(lexical, "BLOCK", 7)
    assert found(spark, docs, items, 10) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == []
    assert found(spark, [(1, "a")], [], 5) == []
    assert found(spark, [(1, None)], [(1, "a")], 5) == []


def test_bound_holds_for_every_term():
    draw = random.Random(4)
    for _ in range(50):
        own = Counter(f"t{draw.randrange(3000)}".encode() for _ in range(draw.choice([1, 10, 3000])))
        own[b"often"] = draw.choice([1, 300, 10**6])
        terms, counts = list(own), np.fromiter(own.values(), np.int32, len(own))
        sketch = lexical.sketch_of(terms, counts)
        for t, n in own.items():
            held = sketch[lexical.crc32(t) & (len(sketch) - 1)]
            assert held >= n or held == lexical.MOST
    grown = lexical.saturated(np.arange(1, 1000), 77)
    assert (np.diff(grown) >= 0).all() and grown.max() < 1_000_000


def test_few_documents_are_rescored(spark, monkeypatch):
    """Bounds keep most documents from being read: in one task nearly all of these share no rare term with the item."""
    draw = random.Random(8)
    rows = [(f"c{draw.randrange(40)} " * 3 + " ".join(f"r{draw.randrange(10**6)}" for _ in range(40))).encode() for _ in range(2000)]
    rows[7] += b" rare one two three"
    n = 0
    import pyarrow as pa
    docs = [(i, Counter(lexical.terms_of(t))) for i, t in enumerate(rows)]
    batch = lexical.Batch([(1, ["one", "rare", "three", "two", "c1"])])
    index = pa.record_batch({"doc_id": pa.array(range(2000), pa.int64()), "n": pa.array([c.total() for _, c in docs], pa.int64()),
        "terms": pa.array([b" ".join(c) for _, c in docs], pa.binary()), "counts": pa.array([np.fromiter(c.values(), np.int32).tobytes() for _, c in docs], pa.binary()),
        "sketch": pa.array([lexical.sketch_of(list(c), np.fromiter(c.values(), np.int32)).tobytes() for _, c in docs], pa.binary())})
    plain = lexical.saturated
    def counted(counts, m):
        nonlocal n
        n += len(counts) != lexical.MOST + 1
        return plain(counts, m)
    monkeypatch.setattr(lexical, "saturated", counted)
    total = sum(c.total() for _, c in docs)
    out = next(iter(lexical._searched(batch, np.array([7000, 7000, 7000, 7000, 2000]), 2000, total, np.zeros(1, np.int64), 1)([index])))
    assert out.column("doc_id").to_pylist() == [7] and n < 1000
